"""URL filter: host reputation by empirical Bayes, under a list of allow and block rules.

Labelled pages are outcomes, good or bad, of their host. A host's rate of bad pages has a beta prior whose mean is
the posterior mean of its registered domain, whose prior mean is that of its suffix, whose prior mean is the rate of the
whole corpus. The weight of each prior, in pages, is estimated from the labelled outcomes of its level by the method of
moments: with N children of n_i pages and rates p_i around the mean m of all pages, the between-children variance is
``v = (S - (N - 1) * m * (1 - m)) / (n - sum(n_i^2) / n)`` with ``S = sum(n_i * (p_i - m)^2)``, and the weight is
``m * (1 - m) / v - 1``, kept between ``least`` and ``most``. A host whose posterior lower bound,
mean - z * deviation, is above the limit is blocked; all others, also hosts without labels, are allowed.

The registered domain is the last two labels of a host, the suffix its last one (``suffix_labels``; a public list of
suffixes may be given by its labels). A rule (host, path prefix) fits its host and all subdomains; the longest wins, by
the host's and then by the path's length.

Scale. Outcomes are merged per host ahead of the shuffle; all levels above are sums of that table. The verdict of
a host joins the pages as a table that was counted: broadcast if small, else by a join that splits hot hosts. Rules are a
small literal list and apply as one expression per page.

Defined cases: a null url, or one without ``://``, has an empty host and path, no rule, and the verdict of the empty
host, whose outcomes do not count; labels that are null are ignored; several labels of a page all count; repeated
pages are each judged; without any label every host is allowed; empty tables give empty ones.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom import runtime
from feedloom.llm.common import ascii_lower, landed, table

# Rules as (verdict, host, path prefix).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


@dataclass(frozen=True)
class Reputation:
    """Parameters of the method: block when the lower bound at ``z`` deviations passes ``limit``."""

    z: float = 1.645
    limit: float = 0.2
    least: float = 1.0
    most: float = 1000.0
    suffix_labels: int = 1


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without it."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest fitting rule, null if none fits."""
    ordered = sorted(rules, key=lambda rule: (-len(rule[1]), -len(rule[2])))
    name = verdict = None
    for said, rule_host, prefix in ordered:
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(prefix)
        name = (F if name is None else name).when(fits, F.lit(f"{rule_host}{prefix}"))
        verdict = (F if verdict is None else verdict).when(fits, F.lit(said))
    return name, verdict


def _last(host: Column, labels: int) -> Column:
    return F.substring_index(host, ".", -labels)


def _weight(children: DataFrame, method: Reputation) -> Column:
    """Weight of the prior that the children of one level share, from their (n, bad); one row."""
    rate = children.agg(
        F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("n")).alias("squares"),
        F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("spread"),
    )
    # S = sum(bad_i^2 / n_i) - n * m^2
    return rate.selectExpr(f"{_WEIGHT.format(least=float(method.least), most=float(method.most))} AS weight", "bad / n AS mean")


_WEIGHT = """CASE WHEN n * 1.0D - squares / n > 0
     AND spread - n * (bad / n) * (bad / n) - (k - 1) * (bad / n) * (1 - bad / n) > 0
  THEN greatest({least}D, least({most}D, (bad / n) * (1 - bad / n) * (n * 1.0D - squares / n)
     / (spread - n * (bad / n) * (bad / n) - (k - 1) * (bad / n) * (1 - bad / n)) - 1))
  ELSE {most}D END"""


def host_scores(outcomes: DataFrame, method: Reputation = Reputation()) -> DataFrame:
    """(host, n, bad, mean, lower) of every host with labels; ``outcomes`` has host and bad (0 or 1)."""
    hosts = outcomes.where("host != '' AND bad IS NOT NULL").groupBy("host").agg(
        F.count("*").cast("double").alias("n"), F.sum("bad").cast("double").alias("bad")
    )
    hosts = hosts.withColumn("suffix", _last(F.col("host"), method.suffix_labels))
    hosts = landed(hosts.withColumn("domain", _last(F.col("host"), method.suffix_labels + 1)), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))

    def posterior(nodes: DataFrame, prior: Column) -> DataFrame:
        # One row: the weight and mean that all nodes of the level share.
        nodes = nodes.crossJoin(F.broadcast(_weight(nodes, method)))
        nodes = nodes.withColumn("prior", F.coalesce(prior, F.col("mean")))
        return nodes.withColumn("posterior", (F.col("bad") + F.col("weight") * F.col("prior")) / (F.col("n") + F.col("weight")))

    suffixes = posterior(suffixes, F.lit(None).cast("double")).select("suffix", F.col("posterior").alias("above"))
    domains = posterior(domains.join(suffixes, "suffix"), F.col("above")).select("domain", "suffix", F.col("posterior").alias("above"))
    hosts = posterior(hosts.join(domains, ["domain", "suffix"]), F.col("above"))
    seen = F.col("n") + F.col("weight")
    deviation = F.sqrt(F.col("posterior") * (1 - F.col("posterior")) / (seen + 1))
    return hosts.select("host", "n", "bad", F.col("posterior").alias("mean"), (F.col("posterior") - method.z * deviation).alias("lower"))


def judge(pages: DataFrame, outcomes: DataFrame, method: Reputation = Reputation(), rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, lower) of every page.

    ``outcomes`` has page_id and bad: 1 for a bad page, 0 for a good one.
    """
    urls = pages.select("page_id", host_of(pages["url"]).alias("host"), path_of(pages["url"]).alias("path"))
    labelled = outcomes.select(F.col("page_id"), F.col("bad")).where("bad IS NOT NULL")
    scores = landed(host_scores(urls.select("page_id", "host").join(labelled, "page_id"), method), "host-scores")
    blocked = scores.select("host", "lower")
    joined = urls.join(F.broadcast(blocked) if runtime.fits_broadcast(blocked) else blocked, "host", "left")
    name, said = rule_of(F.col("host"), F.col("path"), rules)
    method_says = F.when(F.col("lower") > method.limit, "block").otherwise("allow")
    return joined.select(
        "page_id", "host", "path", name.alias("rule"), F.coalesce(said, method_says).alias("verdict"), "lower"
    )


def filter_pages(pages: DataFrame, outcomes: DataFrame, method: Reputation = Reputation(), rules=RULES) -> DataFrame:
    """The pages with the verdict allow, all columns kept; a page without an id is judged by its url alone."""
    urls = pages.select("page_id", "url").distinct()
    verdicts = judge(urls.select("page_id", "url"), outcomes, method, rules).where("verdict = 'block'")
    gone = landed(verdicts.select(F.col("host").alias("b_host"), F.col("path").alias("b_path")).distinct(), "blocked")
    same = (host_of(pages["url"]) == gone["b_host"]) & (path_of(pages["url"]) == gone["b_path"])
    return pages.join(F.broadcast(gone) if runtime.fits_broadcast(gone) else gone, same, "left_anti")


def outcomes_of(labels: DataFrame) -> DataFrame:
    """Outcomes from the labels of the documents that the pages gave: bad if the quality label is 0."""
    return labels.select(F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad"))


def _sql(method: Reputation = Reputation(), rules=RULES) -> str:
    weight = _WEIGHT.format(least=float(method.least), most=float(method.most)).replace("D,", ",").replace("1.0D", "1.0").replace("D END", " END")
    ordered = sorted(rules, key=lambda rule: (-len(rule[1]), -len(rule[2])))
    fits = [f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))" for _, h, p in ordered]
    name = " ".join(f"WHEN {fit} THEN '{h}{p}'" for fit, (_, h, p) in zip(fits, ordered))
    said = " ".join(f"WHEN {fit} THEN '{v}'" for fit, (v, _, _) in zip(fits, ordered))
    level = lambda t: f"(SELECT {weight} AS weight, bad / n AS mean FROM (SELECT sum(n) AS n, sum(bad) AS bad, count(*) AS k, sum(n * n) AS squares, sum(bad * bad / n) AS spread FROM {t}))"
    last = lambda k: f"array_to_string(list_slice(string_split(host, '.'), greatest(len(string_split(host, '.')) - {k - 1}, 1), len(string_split(host, '.'))), '.')"
    k = method.suffix_labels
    return f"""
WITH u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
     coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
h AS (SELECT host, {last(k)} AS suffix, {last(k + 1)} AS domain, CAST(count(*) AS DOUBLE) AS n, CAST(sum(1 - quality) AS DOUBLE) AS bad
      FROM u JOIN labels ON page_id = labels.doc_id WHERE host <> '' AND quality IS NOT NULL GROUP BY host),
d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY domain, suffix),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY suffix),
sp AS (SELECT suffix, (bad + weight * mean) / (n + weight) AS above FROM s, {level("s")}),
dp AS (SELECT domain, suffix, (bad + weight * above) / (n + weight) AS above FROM d JOIN sp USING (suffix), {level("d")}),
hp AS (SELECT host, n + weight AS seen, (bad + weight * above) / (n + weight) AS p
       FROM h JOIN dp USING (domain, suffix), {level("h")})
SELECT page_id, u.host, path, CASE {name} END AS rule,
  CASE {said} WHEN p - {method.z} * sqrt(p * (1 - p) / (seen + 1)) > {method.limit} THEN 'block' ELSE 'allow' END AS verdict
FROM u LEFT JOIN hp ON u.host = hp.host
""".replace("(host = ", "(u.host = ").replace("ends_with(host", "ends_with(u.host")


SQL = _sql()


def op5_url_filter(spark, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "pages"), outcomes_of(table(spark, sf_dir, "labels")))
    return judged.drop("lower")
