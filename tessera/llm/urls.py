"""URL filter: longest-match rules first, a character language-model ratio for the rest.

Only DataFrame functions run here. Two variable-order Markov models over an alphabet of 32
symbols, one of accepted and one of rejected URLs, interpolate orders 1 to 3, each order
smoothed towards the next shorter one. What a rule decides is their training data, but that
URLs with a seed word count as rejected. A URL's score is the mean over its characters of
ln p(rejected) - ln p(accepted), rounded to three decimals; it is blocked above the cut, the
larger of 0 and the score that the share `keep` of the accepted training URLs does not exceed.

Both models are one array of 32**3 numbers, whatever the number of URLs: it reaches the scan as
a scalar subquery, so scoring neither joins nor shuffles, and only pre-aggregated counts move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The symbols; digits become 0, any other character ~, which also pads.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0./-_~"
#: Parts of URLs that go with unwanted pages.
SEEDS = ("adult", "casino", "free-bet", "porn", "poker", "spam", "viagra", "xxx")
MU, KEEP = 4.0, 0.99

#: The rules of the contract: (verdict, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parsed(pages: DataFrame, *extra: str) -> DataFrame:
    """page_id, host, path: both empty where url is null or has no '://'."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return pages.select("page_id", *extra, F.coalesce(host, F.lit("")).alias("host"), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit("")).alias("path"))


def ruled(parts: DataFrame, rules=RULES) -> DataFrame:
    """parts with rule (host + path of the longest rule that fits, else null) and said (its verdict)."""
    rule, said = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))
        rule, said = F.when(fits, host + path).otherwise(rule), F.when(fits, verdict).otherwise(said)
    return parts.withColumn("rule", rule).withColumn("said", said)


def _padded() -> Column:
    low = F.translate(F.concat("host", "path"), _UPPER, _LOWER)
    return F.concat(F.lit("~~"), F.regexp_replace(F.regexp_replace(low, r"[0-9]", "0"), r"[^a-z0./_-]", "~"), F.lit("~"))


def _codes(text: str) -> Column:
    sym = lambda k: f"(instr('{ALPHABET}', substring({text}, i - {k}, 1)) - 1)"
    return F.expr(f"transform(sequence(3, length({text})), i -> {sym(2)} * 1024 + {sym(1)} * 32 + {sym(0)})")


def model(train: DataFrame) -> DataFrame:
    """One row, one column: the array of ln p(rejected) - ln p(accepted) by trigram number.

    train has the columns p (padded text) and y (1 rejected, 0 accepted).
    """
    seen = train.select("y", F.explode(_codes("p")).alias("code")).groupBy("code").agg(F.sum("y").alias("r"), F.sum(1 - F.col("y")).alias("a"))
    grid = train.sparkSession.range(len(ALPHABET) ** 3).withColumnRenamed("id", "code").join(seen, "code", "left").na.fill(0, ["r", "a"])
    context, pair, middle, last = F.expr("code div 32"), F.col("code") % 1024, F.expr("code div 32") % 32, F.col("code") % 32

    def log_p(c: str) -> Column:
        total = lambda *by: F.sum(c).over(Window.partitionBy(*by))
        p1 = (total(last) + MU / 32) / (total(F.lit(0)) + MU)
        p2 = (total(pair) + MU * p1) / (total(middle) + MU)
        return F.log((F.col(c) + MU * p2) / (total(context) + MU))

    ratio = grid.select("code", (log_p("r") - log_p("a")).alias("llr"))
    return ratio.agg(F.transform(F.array_sort(F.collect_list(F.struct("code", "llr"))), lambda x: x["llr"]).alias("llr"))


def filtered(spark: SparkSession, pages: DataFrame, rules=RULES, seeds=SEEDS, keep: float = KEEP) -> DataFrame:
    """page_id, host, path, rule, verdict and score for every row of pages (page_id, url).

    A null url, or one without '://', has an empty host and path, fits no rule and is judged by
    the model like any other. A null page_id stays null, repeated rows stay, further columns are
    not read. Without training URLs every score is 0 and the verdict is allow.
    """
    parts = ruled(parsed(pages), rules).withColumn("p", _padded())
    seed = F.lit(False)
    for word in seeds:
        seed = seed | F.contains(F.concat("host", "path"), F.lit(word))
    train = parts.filter(F.col("said").isNotNull() | seed).withColumn("y", F.when(seed | (F.col("said") == "block"), 1).otherwise(0))
    table = model(train.select("p", "y"))

    def scored(df: DataFrame) -> DataFrame:
        held = df.withColumn("codes", _codes("p")).withColumn("llr", table.scalar())
        return held.withColumn("score", F.round(F.expr("aggregate(codes, 0D, (s, c) -> s + element_at(llr, cast(c + 1 as int)))") / (F.length("p") - 2), 3)).drop("llr", "codes")

    hist = scored(train.filter("y = 0").select("p")).groupBy("score").count()  # a row for each thousandth
    run, whole = F.sum("count").over(Window.orderBy("score")), F.sum("count").over(Window.partitionBy())
    cut = hist.select("score", (run >= keep * whole).alias("enough")).filter("enough").agg(F.greatest(F.min("score"), F.lit(0.0)).alias("cut"))
    judged = scored(parts).withColumn("cut", F.coalesce(cut.scalar(), F.lit(0.0)))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("said", F.when(F.col("score") > F.col("cut"), "block").otherwise("allow")).alias("verdict"), "score")


def sql(rules=RULES, seeds=SEEDS, keep: float = KEEP) -> str:
    """The same rows in DuckDB SQL, with the models as joins instead of an array."""
    order = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fit = [(v, h + p, f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')") for v, h, p in order]
    rule = " ".join(f"when {w} then '{s}'" for _, s, w in fit)
    said = " ".join(f"when {w} then '{v}'" for v, _, w in fit)
    seed = " or ".join(f"contains(host || path, '{w}')" for w in seeds)
    sym = lambda k: f"(instr('{ALPHABET}', substr(p, i - {k}, 1)) - 1)"
    log_p = lambda c: f"ln(({c} + {MU} * (sum({c}) over (partition by code % 1024) + {MU} * (sum({c}) over (partition by code % 32) + {MU} / 32) / (sum({c}) over () + {MU})) / (sum({c}) over (partition by code // 32 % 32) + {MU})) / (sum({c}) over (partition by code // 32) + {MU}))"
    return rf"""
with cut as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
parts as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path, row_number() over () as n from cut),
said as (select *, case {rule} end as rule, case {said} end as said, ({seed}) as seed,
  '~~' || regexp_replace(regexp_replace(translate(host || path, '{_UPPER}', '{_LOWER}'), '[0-9]', '0', 'g'), '[^a-z0./_-]', '~', 'g') || '~' as p from parts),
grams as (select n, i, {sym(2)} * 1024 + {sym(1)} * 32 + {sym(0)} as code from (select n, p, unnest(range(3, length(p) + 1)) as i from said)),
train as (select n, case when seed or said = 'block' then 1 else 0 end as y from said where said is not null or seed),
seen as (select code, sum(y) as r, sum(1 - y) as a from grams join train using (n) group by code),
grid as (select g.code, coalesce(r, 0) as r, coalesce(a, 0) as a from (select unnest(range(0, 32768)) as code) g left join seen using (code)),
model as (select code, {log_p("r")} - {log_p("a")} as llr from grid),
scores as (select n, round(sum(llr order by i) / count(*), 3) as score from grams join model using (code) group by n),
hist as (select score, count(*) as c from scores join train using (n) where y = 0 group by score),
bound as (select coalesce(greatest(min(score), 0), 0) as bound from (select score, sum(c) over (order by score) >= {keep} * sum(c) over () as enough from hist) where enough)
select page_id, host, path, rule, coalesce(said, case when score > bound then 'block' else 'allow' end) as verdict
from said join scores using (n), bound
"""
