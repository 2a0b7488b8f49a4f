"""URL filter: explicit rules first, then empirical-Bayes host reputation.

Pages that a rule decides are the labelled outcomes (block = 1). Counts are shrunk through
beta-binomial priors from the whole table to the suffix, the registered domain and the host; each
level's prior strength comes from the spread between its groups (method of moments). A host whose
posterior lower bound exceeds one half is blocked.

For reputation a host is taken without user info, port and final dots. Its suffix is the last label, or the last
two if they are a country's code after one of ``SECOND_LEVEL`` (co.uk, com.br); the registered domain has one
label more. An address in numbers is its own domain and has the suffix ``ip``.

Defined results: a null url, or one without ``://``, has empty host and path and is judged by the
counts of the empty host; with no labelled page at all the prior mean is one half and nothing is
blocked. Null ids, repeated pages and urls of any length each get a row; an empty table gives no rows; other
columns are ignored. Counts are summed before they are shuffled, and the table of hosts is written, so that Spark
broadcasts it where it is small and otherwise splits what a dominant host joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import ascii_lower, materialize

#: Rule host, rule path, verdict.
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
Z = 1.645
WEAKEST, STRONGEST = 1.0, 1000.0
MAX_RULES = 500
#: Second-level labels under which countries register names.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gob", "gov", "gouv", "go", "gv", "mil", "ne", "net", "nom", "or", "org", "sch")
_TWO_LABELS = rf"(^|[.])({'|'.join(SECOND_LEVEL)})[.][a-z][a-z]$"
_NUMBERS = r"^([0-9]{1,3}[.]){3}[0-9]{1,3}$|^\["


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def with_host_and_path(pages: DataFrame, url_col: str = "url") -> DataFrame:
    rest = _after_scheme(F.col(url_col))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return pages.withColumns({"host": ascii_lower(host), "path": path})


def matched_rule(rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits host and path; null where none does."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules become expressions")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, said in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _prior(groups: DataFrame) -> tuple[float, float]:
    """(pooled mean, prior strength) from the spread of k/n between groups, by the method of moments."""
    x = groups.agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum(F.when(F.col("n") > 0, F.col("k") * F.col("k") / F.col("n"))).alias("q")).first()
    n, k, q = x.n or 0, x.k or 0, x.q or 0.0
    mean = (k + 1) / (n + 2)
    spread = (q - 2 * mean * k + mean * mean * n) / n if n else 0.0
    strength = mean * (1 - mean) / spread - 1 if spread > 0 else STRONGEST
    return mean, min(STRONGEST, max(WEAKEST, strength))


def _shrunk(prior_mean: Column, strength: float) -> Column:
    return (F.col("k") + strength * prior_mean) / (F.col("n") + strength)


def with_site(pages: DataFrame) -> DataFrame:
    """Adds site (the host without user info, port and final dots)."""
    bare = F.regexp_replace(F.regexp_replace("host", "^([^@]*@)+", ""), ":[0-9]*$", "")
    return pages.withColumn("site", F.regexp_replace(bare, "[.]+$", ""))


def site_reputation(labelled: DataFrame) -> DataFrame:
    """labelled: site, outcome (1 bad, 0 good, null unlabelled). A row per site: block_probability and its lower bound."""
    two, numbers = F.col("site").rlike(_TWO_LABELS), F.col("site").rlike(_NUMBERS)
    domain = F.when(numbers, F.col("site")).when(two, F.regexp_extract("site", "([^.]*[.])?[^.]*[.][^.]*$", 0)).otherwise(F.regexp_extract("site", "([^.]*[.])?[^.]*$", 0))
    suffix = F.when(numbers, "ip").when(two, F.regexp_extract("site", "[^.]*[.][^.]*$", 0)).otherwise(F.regexp_extract("site", "[^.]*$", 0))
    hosts = labelled.groupBy("site").agg(F.count("outcome").alias("n"), F.coalesce(F.sum("outcome"), F.lit(0)).cast("long").alias("k"))
    hosts = materialize(hosts, "hosts").withColumns({"domain": domain, "suffix": suffix})
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    (root, by_suffix), (_, by_domain), (_, by_host) = _prior(suffixes), _prior(domains), _prior(hosts)
    suffixes = suffixes.select("suffix", _shrunk(F.lit(root), by_suffix).alias("suffix_mean"))
    domains = domains.join(suffixes, "suffix").select("domain", _shrunk(F.col("suffix_mean"), by_domain).alias("domain_mean"))
    mean = _shrunk(F.col("domain_mean"), by_host)
    deviation = F.sqrt(mean * (1 - mean) / (F.col("n") + by_host + 1))
    return hosts.join(domains, "domain").select("site", mean.alias("block_probability"), (mean - Z * deviation).alias("lower_bound"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, url_col: str = "url", id_col: str = "page_id") -> DataFrame:
    """A row per page: id, host, path, rule, verdict, block_probability and its lower bound."""
    rule, verdict = matched_rule(rules)
    judged = with_site(with_host_and_path(pages.select(id_col, url_col), url_col)).withColumns({"rule": rule, "ruled": verdict})
    outcome = F.when(F.col("ruled") == "block", 1).when(F.col("ruled") == "allow", 0)
    hosts = materialize(site_reputation(judged.select("site", outcome.alias("outcome"))), "reputation")
    by_method = F.when(F.col("lower_bound") > 0.5, "block").otherwise("allow")
    return judged.join(hosts, "site").select(id_col, "host", "path", "rule", F.coalesce("ruled", by_method).alias("verdict"), F.round("block_probability", 6).alias("block_probability"), F.round("lower_bound", 6).alias("lower_bound"))


#: The same judgement in SQL over the view ``pages``.
ORACLE = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM cut),
split AS (
  SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path,
         regexp_replace(regexp_replace(regexp_replace(translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^([^@]*@)+', ''), ':[0-9]*$', ''), '[.]+$', '') AS site FROM parts),
rules(rule_host, rule_path, said) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
fits AS (
  SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(said, length(rule_host || rule_path)) AS ruled
  FROM split JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id),
judged AS (SELECT split.*, rule, ruled FROM split LEFT JOIN fits USING (page_id)),
counts AS (SELECT site, count(ruled)::DOUBLE AS n, count(*) FILTER (ruled = 'block')::DOUBLE AS k FROM judged GROUP BY site),
hosts AS (
  SELECT site, n, k,
         CASE WHEN regexp_matches(site, '{_NUMBERS}') THEN site WHEN regexp_matches(site, '{_TWO_LABELS}') THEN regexp_extract(site, '([^.]*[.])?[^.]*[.][^.]*$')
              ELSE regexp_extract(site, '([^.]*[.])?[^.]*$') END AS domain,
         CASE WHEN regexp_matches(site, '{_NUMBERS}') THEN 'ip' WHEN regexp_matches(site, '{_TWO_LABELS}') THEN regexp_extract(site, '[^.]*[.][^.]*$')
              ELSE regexp_extract(site, '[^.]*$') END AS suffix FROM counts),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM domains GROUP BY ALL),
sums AS (
  SELECT 's' AS level, sum(n) AS n, sum(k) AS k, coalesce(sum(k * k / n) FILTER (n > 0), 0) AS q FROM suffixes
  UNION ALL SELECT 'd', sum(n), sum(k), coalesce(sum(k * k / n) FILTER (n > 0), 0) FROM domains
  UNION ALL SELECT 'h', sum(n), sum(k), coalesce(sum(k * k / n) FILTER (n > 0), 0) FROM hosts),
spread AS (
  SELECT level, (k + 1) / (n + 2) AS p, CASE WHEN n > 0 THEN (q - 2 * ((k + 1) / (n + 2)) * k + ((k + 1) / (n + 2)) * ((k + 1) / (n + 2)) * n) / n ELSE 0 END AS v FROM sums),
priors AS (SELECT level, p, CASE WHEN v > 0 THEN least(1000.0::DOUBLE, greatest(1.0::DOUBLE, p * (1 - p) / v - 1)) ELSE 1000.0::DOUBLE END AS m FROM spread),
s AS (SELECT suffix, (k + m * p) / (n + m) AS suffix_mean FROM suffixes, priors WHERE level = 's'),
d AS (SELECT domain, (k + m * suffix_mean) / (n + m) AS domain_mean FROM domains JOIN s USING (suffix), priors WHERE level = 'd'),
h AS (SELECT site, n, m, (k + m * domain_mean) / (n + m) AS mean FROM hosts JOIN d USING (domain), priors WHERE level = 'h'),
bounds AS (SELECT site, mean, mean - 1.645 * sqrt(mean * (1 - mean) / (n + m + 1)) AS low FROM h)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN low > 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
       round(mean, 6) AS block_probability, round(low, 6) AS lower_bound
FROM judged JOIN bounds USING (site)
"""
