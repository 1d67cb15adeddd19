"""Empirical-Bayes host reputation over labelled page outcomes, below a list of rules.

Outcomes (good of n) are counted by host, registered domain and public suffix. Each level shrinks towards the one above by
a beta prior whose mean is the parent's posterior mean and whose strength is fitted, once a level, to how much children
differ between themselves (method of moments). A url without a rule is blocked when the upper bound of its host's posterior
(mean plus Z standard deviations) is below FLOOR: an unseen or thinly labelled host is never blocked by its own few labels.

Everything is DataFrame operations: outcomes are summed before they are shuffled, so a host with a third of all rows is one
row a task. The driver sees three strengths and the corpus's mean, no more. Pages of the fewer than a thousand hot hosts stay in
their tasks when they meet their host's bound; pages and labels meet by page.

Null urls and urls without "://": empty host and path; no rule fits them, and they are one host to
the method. Repeated rows are judged one by one. An empty table gives no rows; without labels every page is allowed. Extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, meet, own, table

#: Fixed values: (action, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Suffixes of more than one label, below which domains are registered.
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp", "com.br", "co.in", "co.nz", "co.za", "com.cn", "com.mx", "co.kr", "com.tr")
#: Standard deviations of the posterior bound; the bound below which a host is blocked; range of a prior's strength.
Z, FLOOR, STRENGTH = 2.0, 0.35, (2.0, 200.0)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*LONG_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*LONG_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two)


def rule_of(host: Column, path: Column, rules=tuple(RULES)) -> tuple[Column, Column]:
    """The longest rule that fits, or null, and its action, or null. Ties: the later in text order of the rule."""
    ordered = sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2]), reverse=True)
    text, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, h, p in reversed(ordered):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, action = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(act)).otherwise(action)
    return text, action


def _strength(children: DataFrame) -> float:
    """The strength of the prior, from children with n, good and the parent's mean m, by moments.

    The spread of children's rates beyond that of their own counts, against m(1 - m), is 1 / (1 + strength)."""
    rate, var = F.col("good") / F.col("n"), F.col("m") * (1 - F.col("m"))
    low, high = STRENGTH
    sums = children.agg(F.sum(F.col("n") * ((rate - F.col("m")) ** 2)).alias("seen"), F.sum(var).alias("own"), F.sum(F.col("n") * var).alias("all"))
    rho = (F.col("seen") - F.col("own")) / F.nullif(F.col("all") - F.col("own"), F.lit(0.0))
    return sums.select(F.coalesce(F.greatest(F.lit(low), F.least(F.lit(high), 1 / F.greatest(rho, F.lit(1e-9)) - 1)), F.lit(high)).alias("k")).first()[0]


def reputation(outcomes: DataFrame) -> DataFrame:
    """From (host, good 0/1): (host, mean, upper) of hosts with outcomes."""
    hosts = outcomes.groupBy("host").agg(F.count("*").cast("double").alias("n"), F.sum(F.col("good").cast("double")).alias("good"))
    work = Scratch(outcomes.sparkSession, "urls")
    hosts = work.keep(hosts.withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))}), "hosts")
    add = [F.sum("n").alias("n"), F.sum("good").alias("good")]
    domains = work.keep(hosts.groupBy("domain", "suffix").agg(*add), "domains")
    suffixes = work.keep(domains.groupBy("suffix").agg(*add), "suffixes")
    m = suffixes.select((F.coalesce(F.sum("good"), F.lit(0.0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0.0)) + 2)).first()[0]

    def shrunk(withm: DataFrame, name: str) -> DataFrame:
        withm = work.keep(withm, name)
        k = F.lit(_strength(withm))
        return withm.withColumns({"a": k * F.col("m") + F.col("good"), "total": k + F.col("n")})

    def below(level: DataFrame, parents: DataFrame, by: str) -> DataFrame:
        children = level.groupBy(by).agg(F.count("*").alias("rows"))
        keys = work.keep(parents.join(children, by).select(by, "m", F.col("rows").alias("n")), f"{by}-means")
        return meet(level.withColumnRenamed("n", "n_outcomes"), keys, by).drop("n").withColumnRenamed("n_outcomes", "n")

    mean = (F.col("a") / F.col("total")).alias("m")
    s = shrunk(suffixes.withColumn("m", F.lit(m)), "suffix").select("suffix", mean)
    d = shrunk(below(domains, s, "suffix"), "domain").select("domain", mean)
    h = shrunk(below(hosts.drop("suffix"), d, "domain"), "host")
    mu = F.col("a") / F.col("total")
    upper = mu + Z * F.sqrt(mu * (1 - mu) / (F.col("total") + 1))
    return h.select("host", mu.alias("mean"), upper.alias("upper"))


def judge(pages: DataFrame, outcomes: DataFrame, rules=tuple(RULES)) -> DataFrame:
    """pages (page_id, url), outcomes (page_id, good 0/1, null: none). A row for each page."""
    split = own(pages, "page_id", "url").select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    labelled = own(outcomes, "page_id", "good").where(F.col("good").isNotNull() & F.col("page_id").isNotNull())
    hosts = reputation(split.join(labelled, "page_id").select("host", "good"))
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("upper") < FLOOR, "block").otherwise("allow")
    keys = split.groupBy("host").agg(F.count("*").alias("n")).join(hosts, "host", "left")
    return meet(split, Scratch(pages.sparkSession, "urls-hosts").keep(keys, "hosts"), "host").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(action, method).alias("verdict"), F.round("mean", 6).alias("host_mean"), F.round("upper", 6).alias("host_upper")
    )


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels are those of the documents with the pages' ids: good when of quality and not toxic."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (F.col("quality") * (1 - F.col("toxic"))).alias("good"))
    return judge(table(spark, sf_dir, "pages"), labels)


def _sql() -> str:
    """The same in DuckDB."""
    long = ", ".join(f"'{x}'" for x in LONG_SUFFIXES)
    fits = lambda h, p: f"((host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}'))"
    ordered = sorted(RULES, key=lambda r: (len(r[1] + r[2]), r[1] + r[2]), reverse=True)
    rule = " ".join(f"when {fits(h, p)} then '{h + p}'" for _, h, p in ordered)
    action = " ".join(f"when {fits(h, p)} then '{a}'" for a, h, p in ordered)
    two = "array_to_string(list_slice(string_split(host, '.'), -2, -1), '.')"
    three = "array_to_string(list_slice(string_split(host, '.'), -3, -1), '.')"
    low, high = STRENGTH
    k = lambda of: f"(select coalesce(greatest({low}, least({high}, 1 / greatest((sum(n * (good / n - m) ** 2) - sum(m * (1 - m))) / nullif(sum(n * m * (1 - m)) - sum(m * (1 - m)), 0), 1e-9) - 1)), {high}) from {of})"
    return f"""
with split as (select page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '{UPPER}', '{LOWER}'), '') host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') path from pages),
outcomes as (select host, quality * (1 - toxic) good from split join labels on page_id = doc_id where quality * (1 - toxic) is not null),
hosts as (select host, count(*)::double n, sum(good)::double good, case when {two} in ({long}) then {three} else {two} end as domain,
    case when {two} in ({long}) then {two} else string_split(host, '.')[-1] end suffix from outcomes group by host),
domains as (select domain, suffix, sum(n) n, sum(good) good from hosts group by all),
suffixes as (select suffix, sum(n) n, sum(good) good from domains group by all),
s0 as (select *, (select (coalesce(sum(good), 0) + 1) / (coalesce(sum(n), 0) + 2) from suffixes) m from suffixes),
s as (select suffix, ({k("s0")} * m + good) / ({k("s0")} + n) m from s0),
d0 as (select domain, suffix, n, good, m from domains join s using (suffix)),
d as (select domain, ({k("d0")} * m + good) / ({k("d0")} + n) m from d0),
h0 as (select host, n, good, m from hosts join d using (domain)),
h as (select host, ({k("h0")} * m + good) / ({k("h0")} + n) mu, {k("h0")} + n total from h0),
judged as (select host, mu, mu + {Z} * sqrt(mu * (1 - mu) / (total + 1)) upper from h)
select page_id, host, path, case {rule} end as rule, coalesce(case {action} end, case when upper < {FLOOR} then 'block' else 'allow' end) verdict,
    round(mu, 6) host_mean, round(upper, 6) host_upper from split left join judged using (host)"""


OP8_SQL = _sql()
