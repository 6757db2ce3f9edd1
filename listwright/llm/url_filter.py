"""URL filters: host reputation by empirical Bayes, after explicit rules.

Labelled page outcomes are counted by host, registered domain and public suffix. Each level is a beta-binomial whose
prior is the posterior mean of the level above; the prior's strength is fitted at each level by moments. A host is
blocked if the lower bound of its posterior for a bad outcome is over RATIO times the rate of all labelled pages. Ports
don't count: pages of one host share its reputation, whatever the port.

Defined cases: a null url, or one without `://`, has an empty host and path, fits no rule and is allowed: it has no
host's reputation, and its outcomes are no evidence. Null labels are no evidence. Repeated pages are judged alike; repeated labels count each time. An empty
table gives an empty result; without labels every rate is 0 and nothing is blocked by the method. Columns of `pages`
other than the key and url never enter; clashing names are therefore harmless.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: (host, path prefix, verdict); a bounded list, since it becomes one expression
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
MAX_RULES = 1000
#: suffixes of two labels that take registrations below them (a parameter; these are the commonest)
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.in")
#: how many times worse than the whole a host must be, at the least, and the normal quantile of that bound (95 %)
RATIO, Z = 1.5, 1.645
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def fitting_rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule whose host is the url's or a parent of it and whose path starts the url's."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules; join them as a table instead")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def without_port(host: Column) -> Column:
    return F.regexp_replace(host, ":[0-9]*$", "")


def domain_and_suffix(host: Column, suffixes=SUFFIXES) -> tuple[Column, Column]:
    n = F.when(F.substring_index(host, ".", -2).isin(*suffixes), 2).otherwise(1)
    suffix = F.when(n == 2, F.substring_index(host, ".", -2)).otherwise(F.substring_index(host, ".", -1))
    domain = F.when(n == 2, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))
    return domain, suffix


def _shrunk(counts: DataFrame, above: DataFrame, key: str) -> DataFrame:
    """Posterior of each group: `counts` (key, parent, n, k) under the means of `above` (parent, mean)."""
    rows = counts.join(above.select(F.col("node").alias("parent"), F.col("mean").alias("prior")), "parent")
    # moments over groups: var(k/n) = m(1-m)/n * (1 + (n-1)/(s+1)); s solves the sum over groups with n > 1
    spread = rows.agg(
        F.sum(F.when(F.col("n") > 1, F.pow(F.col("k") - F.col("n") * F.col("prior"), 2) - F.col("n") * F.col("prior") * (1 - F.col("prior")))).alias("over"),
        F.sum(F.when(F.col("n") > 1, F.col("n") * (F.col("n") - 1) * F.col("prior") * (1 - F.col("prior")))).alias("room"),
    )
    rho = F.least(F.greatest(F.coalesce(F.try_divide("over", "room"), F.lit(0.0)), F.lit(1e-3)), F.lit(0.999))
    strength = F.broadcast(spread.select((1 / rho - 1).alias("s")))  # one row
    return rows.crossJoin(strength).select(
        F.col(key).alias("node"), ((F.col("k") + F.col("s") * F.col("prior")) / (F.col("n") + F.col("s"))).alias("mean"), (F.col("n") + F.col("s")).alias("weight")
    )


def host_reputation(outcomes: DataFrame, suffixes=SUFFIXES) -> DataFrame:
    """(host, bad 0/1 or null) rows -> (host, mean, lower, rate): posterior mean and lower bound of a bad outcome, and the rate of all."""
    host_counts = outcomes.where(F.col("bad").isNotNull() & (F.col("host") != "")).groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("k"))
    domain, suffix = domain_and_suffix(F.col("host"), suffixes)
    hosts = host_counts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "k")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    tops = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    root = tops.agg(F.sum("k").alias("k"), F.sum("n").alias("n")).select(F.lit("*").alias("node"), F.coalesce(F.try_divide("k", "n"), F.lit(0.0)).alias("mean"))
    by_suffix = _shrunk(tops.withColumn("parent", F.lit("*")), root, "suffix")
    by_domain = _shrunk(domains.withColumnRenamed("suffix", "parent"), by_suffix, "domain")
    by_host = _shrunk(hosts.drop("suffix").withColumnRenamed("domain", "parent"), by_domain, "host")
    lower = F.col("mean") - Z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("weight") + 1))
    rate = F.broadcast(root.select(F.col("mean").alias("rate")))  # one row
    return by_host.select(F.col("node").alias("host"), "mean", F.greatest(lower, F.lit(0.0)).alias("lower")).crossJoin(rate)


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, ratio: float = RATIO, page_id: str = "page_id", url: str = "url", label_id: str = "doc_id", bad: str = "toxic") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict."""
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    outcomes = rows.join(labels.select(F.col(label_id).alias("page_id"), F.col(bad).alias("bad")), "page_id").select(without_port(F.col("host")).alias("host"), "bad")
    bad_hosts = host_reputation(outcomes).where(F.col("lower") > ratio * F.col("rate")).select(F.col("host").alias("bare"), F.lit(True).alias("is_bad"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    return rows.withColumn("bare", without_port(F.col("host"))).join(bad_hosts, "bare", "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("is_bad"), "block").otherwise("allow")).alias("verdict")
    )


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict; outcomes are the `toxic` labels whose doc_id is the page's id."""
    return judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


OP3_SQL = """
WITH u AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
h AS (SELECT regexp_replace(host, ':[0-9]*$', '') AS host, count(*) AS n, sum(toxic) AS k FROM p JOIN labels ON doc_id = page_id WHERE toxic IS NOT NULL AND regexp_replace(host, ':[0-9]*$', '') <> '' GROUP BY 1),
h2 AS (SELECT *, string_split(host, '.') AS parts FROM h),
h3 AS (SELECT host, n, k, array_to_string(parts[-2:], '.') IN ('co.uk','org.uk','ac.uk','com.au','co.jp','com.br','co.nz','co.in') AS two, parts FROM h2),
h4 AS (SELECT host, n, k, CASE WHEN two THEN array_to_string(parts[-3:], '.') ELSE array_to_string(parts[-2:], '.') END AS domain,
  CASE WHEN two THEN array_to_string(parts[-2:], '.') ELSE parts[-1] END AS suffix FROM h3),
d AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h4 GROUP BY ALL),
t AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY ALL),
root AS (SELECT coalesce(sum(k) / nullif(sum(n), 0), 0) AS prior FROM t),
t1 AS (SELECT t.*, prior FROM t, root),
ts AS (SELECT 1 / least(greatest(coalesce(sum(CASE WHEN n > 1 THEN (k - n * prior) ** 2 - n * prior * (1 - prior) END) / nullif(sum(CASE WHEN n > 1 THEN n * (n - 1) * prior * (1 - prior) END), 0), 0), 1e-3), 0.999) - 1 AS s FROM t1),
t2 AS (SELECT suffix, (k + s * prior) / (n + s) AS mean FROM t1, ts),
d1 AS (SELECT d.*, mean AS prior FROM d JOIN t2 USING (suffix)),
ds AS (SELECT 1 / least(greatest(coalesce(sum(CASE WHEN n > 1 THEN (k - n * prior) ** 2 - n * prior * (1 - prior) END) / nullif(sum(CASE WHEN n > 1 THEN n * (n - 1) * prior * (1 - prior) END), 0), 0), 1e-3), 0.999) - 1 AS s FROM d1),
d2 AS (SELECT domain, (k + s * prior) / (n + s) AS mean FROM d1, ds),
h5 AS (SELECT h4.*, mean AS prior FROM h4 JOIN d2 USING (domain)),
hs AS (SELECT 1 / least(greatest(coalesce(sum(CASE WHEN n > 1 THEN (k - n * prior) ** 2 - n * prior * (1 - prior) END) / nullif(sum(CASE WHEN n > 1 THEN n * (n - 1) * prior * (1 - prior) END), 0), 0), 1e-3), 0.999) - 1 AS s FROM h5),
h6 AS (SELECT host, (k + s * prior) / (n + s) AS mean, n + s AS weight FROM h5, hs),
b AS (SELECT host FROM h6, root WHERE mean - 1.645 * sqrt(mean * (1 - mean) / (weight + 1)) > 1.5 * root.prior),
r AS (SELECT page_id, p.host, path, b.host IS NOT NULL AS bad, CASE
  WHEN (p.host = 'example.com' OR p.host LIKE '%.example.com') AND starts_with(path, '/en/7') THEN 'example.com/en/7'
  WHEN (p.host = 'example.net' OR p.host LIKE '%.example.net') AND starts_with(path, '/de/8') THEN 'example.net/de/8'
  WHEN (p.host = 'com' OR p.host LIKE '%.com') AND starts_with(path, '/en/') THEN 'com/en/'
  WHEN (p.host = 'net' OR p.host LIKE '%.net') AND starts_with(path, '/de/') THEN 'net/de/'
  WHEN (p.host = 'org' OR p.host LIKE '%.org') AND starts_with(path, '/es/') THEN 'org/es/' END AS rule FROM p LEFT JOIN b ON regexp_replace(p.host, ':[0-9]*$', '') = b.host)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN bad THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
